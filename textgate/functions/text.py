"""Scalar text functions as Columns. They stay in the JVM, but for NFKC, which has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as X


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row: inside a lambda of body an expression would run for each element."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def whitespace_tokens(text: Column) -> Column:
    return find_all(text, r"[^\p{Z}\s\x1c-\x1f\x85]+")


def mining_words(text: Column) -> Column:
    return find_all(text, X.MINING_WORD)


def bench_words(text: Column) -> Column:
    return find_all(text, X.BENCH_WORD)


def sentences(text: Column, least: int = 1) -> Column:
    """Sentences of at least `least` white-space separated tokens (mining: 3, style: 1)."""
    return F.filter(F.split(text, X.SENTENCE_END), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")


def lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    parts = F.split(text, X.LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def literal_count(text: Column, literal: str) -> Column:
    """Whole-word occurrences of a literal; a boundary stands where exactly one side is a word character."""
    edge = lambda c, near, far: (near if c.isalnum() or c == "_" else far)
    left = edge(literal[0], X.NOT_BEFORE, rf"(?<={X.W})")
    right = edge(literal[-1], X.NOT_AFTER, rf"(?={X.W})")
    quoted = "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in literal)
    return count(text, left + quoted + right)


def body_without(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, X.CITATION_BRACKET, " "), X.CITATION_AUTHOR, " "), X.DOI, " ")


def citations(text: Column) -> Column:
    return F.concat(find_all(text, X.CITATION_BRACKET), find_all(text, X.CITATION_AUTHOR))


def dois(text: Column) -> Column:
    return find_all(text, X.DOI)


def numbers_in(body: Column) -> Column:
    """Numbers of a text that has no citations and DOIs any more (body_without)."""
    return find_all(body, X.NUMBER)


def quantities_in(body: Column) -> Column:
    return F.zip_with(find_all(body, X.QUANTITY, 1), find_all(body, X.QUANTITY, 2), lambda n, u: F.trim(F.concat(n, F.lit(" "), F.coalesce(u, F.lit("")))))


def numbers(text: Column) -> Column:
    return numbers_in(body_without(text))


def quantities(text: Column) -> Column:
    return let(body_without(text), quantities_in)


def formulas(text: Column) -> Column:
    return formulas_in(body_without(text))


def is_formula(token: Column) -> Column:
    """Two parts or more, all of them elements, and a digit, a lower-case second letter or a third part."""
    parts = find_all(token, X.FORMULA_PART)
    elements = F.array(*[F.lit(e) for e in X.ELEMENTS])
    known = F.forall(parts, lambda p: F.array_contains(elements, F.regexp_replace(p, r"\d", "")))
    return (F.size(parts) >= 2) & known & (token.rlike(r"\d") | token.rlike("[a-z]") | (F.size(parts) >= 3))


def formulas_in(body: Column) -> Column:
    return F.filter(find_all(body, X.FORMULA), is_formula)


def _any_of(signs: str) -> str:
    return "[" + "".join("\\" + c if c in "+*/-^]" else c for c in signs) + "]"


def equations(text: Column) -> Column:
    """Maximal runs of equation atoms with an equality sign, trimmed of joining signs and punctuation at the ends."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_any_of(X.EQUAL_SIGNS)), _equations(text)).otherwise(none)


def _equations(text: Column) -> Column:
    core = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[()\[\],.;:!?]+", ""), r"[()\[\],.;:!?]+$", "")
    inner = rf"{_any_of(X.MATH_SIGNS)}|\p{{Nd}}|^\p{{L}}$"
    atom = lambda t: t.rlike(_any_of(X.EQUAL_SIGNS + X.JOIN_SIGNS) + "|_") | core(t).rlike(inner)
    mark = F.transform(whitespace_tokens(text), lambda t: F.when(atom(t), t).otherwise(F.lit("\u0001")))
    runs = F.filter(F.transform(F.split(F.array_join(mark, " "), "\u0001"), lambda r: F.trim(r)), lambda r: r.rlike(_any_of(X.EQUAL_SIGNS)))
    joins = _any_of(X.JOIN_SIGNS)
    trimmed = F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, rf"^(?:{joins} )+", ""), rf"(?: {joins})+$", ""))
    bare = F.transform(trimmed, lambda r: F.regexp_replace(F.regexp_replace(r, r"^[\s(\[,.;:!?]+", ""), r"[\s),.;:!?]+$", ""))
    return F.filter(bare, lambda r: r.rlike(_any_of(X.EQUAL_SIGNS)))


def section_role(heading: Column) -> Column:
    low = F.lower(F.trim(heading))
    role = F.when((low.contains("result") | low.contains("finding")) & low.contains("discussion"), F.lit("merged: results+discussion"))
    for name, words in X.SECTION_ROLES.items():
        role = role.when(low.isin(*words), F.lit(name))
    return role


def trim_expansion(expansion: Column, acronym: Column) -> Column:
    """The words from the first on whose initial is the acronym's; '' if there is none."""
    words = F.filter(F.split(expansion, " "), lambda w: w != "")
    hit = F.array_position(F.transform(words, lambda w: F.lower(F.substring(w, 1, 1))), F.lower(F.substring(acronym, 1, 1)))
    return F.when(hit > 0, F.array_join(F.slice(words, F.greatest(hit, F.lit(1)).cast("int"), F.size(words)), " ")).otherwise(F.lit(""))


def definitions(text: Column) -> Column:
    """(acronym, expansion, kind) in order: forward definitions, then reverse ones. The patterns try each letter as an expansion's
    first; texts without an acronym before or in brackets are told by a cheaper pattern."""
    forward = F.zip_with(find_all(text, X.DEFINED_FORWARD, 1), find_all(text, X.DEFINED_FORWARD, 2), lambda e, a: F.struct(a.alias("acronym"), trim_expansion(e, a).alias("expansion"), F.lit(0).alias("kind")))
    reverse = F.zip_with(find_all(text, X.DEFINED_REVERSE, 1), find_all(text, X.DEFINED_REVERSE, 2), lambda a, e: F.struct(a.alias("acronym"), e.alias("expansion"), F.lit(1).alias("kind")))
    none = F.array().cast("array<struct<acronym: string, expansion: string, kind: int>>")
    return F.concat(F.when(text.rlike(r" \([A-Z][A-Za-z0-9]{1,9}%?\)"), forward).otherwise(none), F.when(text.rlike(r"[A-Z][A-Za-z0-9]{1,9} \([a-z]"), reverse).otherwise(none))


def plausible_expansion(expansion: Column) -> Column:
    return (F.length(expansion) >= 3) & ~F.lower(expansion).rlike("|".join(X.AFFILIATIONS))


def acronyms(text: Column) -> Column:
    return F.filter(find_all(text, X.ACRONYM, 1), lambda a: ~a.rlike("[a-z]"))


def figure_numbers(text: Column) -> Column:
    return F.transform(find_all(text, X.FIGURE, 1), lambda n: n.cast("int"))


def licence(text: Column) -> Column:
    """Normalised licence name from a licence URL or else the licence's wording; null if neither is there."""
    flat = F.regexp_replace(text, r"\s+", " ")
    name = lambda kind, version: F.concat(F.lit("CC "), F.upper(kind), F.lit(" "), version)
    by_url = F.when(flat.rlike(X.LICENCE_URL), name(F.regexp_extract(flat, X.LICENCE_URL, 1), F.regexp_extract(flat, X.LICENCE_URL, 2)))
    return F.coalesce(by_url, F.when(flat.rlike(X.LICENCE_TEXT), F.concat(F.lit("CC BY"), F.upper(F.regexp_extract(flat, X.LICENCE_TEXT, 1)), F.lit(" "), F.regexp_extract(flat, X.LICENCE_TEXT, 2))))


def slug(text: Column) -> Column:
    got = F.array_join(find_all(F.lower(text), r"[\p{L}\p{N}]+"), "-")
    return F.when(got == "", F.lit("field")).otherwise(got)


def authors(text: Column, most: int = 3) -> Column:
    names = F.filter(F.transform(F.split(text, ";"), F.trim), lambda a: a != "")
    return F.when(F.size(names) > most, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def passage(text: Column) -> Column:
    """The first sentence of five tokens or more, else the first 80 words if there are five; null otherwise."""
    squeeze = lambda s: F.array_join(F.filter(F.split(s, r"\s+"), lambda w: w != ""), " ")
    long_enough = F.filter(F.transform(F.split(F.regexp_replace(text, "\n", " "), r"(?<=[.!?])\s+"), squeeze), lambda s: F.size(F.split(s, " ")) >= 5)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(long_enough, F.lit(1)), F.when(F.size(words) >= 5, F.array_join(F.slice(words, 1, 80), " ")))


def hour_unit(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d)\s*시간", "$1 h")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    return F.when(F.length(needle) > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize(text: Column) -> Column:
    """NFKC (which also makes subscript digits plain); ASCII texts don't leave the JVM's value."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_nfkc(text))


def relative_path(path: Column) -> Column:
    """The path without `.`, doubled separators and what `..` undoes; null if it is empty, absolute or leaves its root."""
    step = lambda done, p: (
        F.when(p.isin("", "."), done)
        .when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, p))
    )
    parts = F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step)
    fine = (path != "") & ~path.rlike(r"^[/\\]")
    return F.when(fine, let(parts, lambda ps: F.when(F.size(ps) == 0, F.lit(".")).when(ps[0] != "..", F.array_join(ps, "/"))))


def redacted(json: Column) -> Column:
    """JSON text whose string values that are absolute paths are hidden; keys stay."""
    return F.regexp_replace(json, r'(?<=[\[:,])(\s*)"/(?:[^"\\]|\\.)*"(?!\s*:)', '$1"<redacted-absolute-path>"')


def match_starts(text: Column, pattern: str) -> Column:
    """Where the matches of a pattern begin, from 0: a mark is put before each and the text split there."""
    plain = F.replace(text, F.lit("\u0001"), F.lit(" "))
    pieces = F.transform(F.split(F.regexp_replace(plain, pattern, "\u0001$0"), "\u0001"), F.length)
    return let(pieces, lambda sizes: F.transform(F.slice(sizes, 2, F.size(sizes)), lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda n, x: n + x)))


def definition_contexts(text: Column) -> Column:
    """Beside each of definitions(): the definition with up to 80 characters before it, of which the last 160 count."""
    before = lambda start: F.substring(text, F.greatest(start - 80, F.lit(0)) + 1, F.least(start, F.lit(80)))
    last = lambda s: F.when(F.length(s) > 160, F.right(s, F.lit(160))).otherwise(s)
    of = lambda pattern: F.zip_with(match_starts(text, pattern), find_all(text, pattern), lambda start, m: last(F.replace(F.concat(before(start), m), F.lit("\n"), F.lit(" "))))
    return F.concat(of(X.DEFINED_FORWARD), of(X.DEFINED_REVERSE))
