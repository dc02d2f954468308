"""The registered queries over the supplied tables, each with DuckDB SQL for the same rows where SQL can express them.

`source` stands for the field of a paper. Near copies (documents that share their first 60 characters) stand for edit pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as X
from ..functions import text as T
from ..operators import attribution, benchmark, coverage, generate, history, invariants, journal, lint, mining, registry, routing, sections
from ..sources import rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
STOP = ("the", "of", "and", "to", "in", "is", "that", "it")
ANCHORS = ("that", "with", "from", "this")
FAMILIES = (("thenon", "the non", "the-non"), ("tion", "ti on"), ("of the", "of-the", "ofthe"))
TERMS = (("f1", "the", 2), ("f1", "of and", 1), ("f2", "and", 2), ("f2", "in the", 1), ("f3", "de", 2), ("f3", "de la", 1), ("f4", "der", 2), ("f4", "und", 1), ("f5", "le", 1))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


def manifest(d: DataFrame) -> DataFrame:
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), "source", "doc_id", F.octet_length("text").cast("bigint").alias("size"), F.sha1("text").alias("sha1"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, original, corrected: the document of smallest id of those with the same beginning, and each other text."""
    d = docs(spark, sf_dir).select("doc_id", "text", F.substring("text", 1, 60).alias("k"))
    first = d.groupBy("k").agg(F.min_by("text", "doc_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, "k").where("text <> original").select(F.col("doc_id").alias("pair_id"), "original", F.col("text").alias("corrected"))


PAIRS = """with d as (select doc_id, text, substr(text, 1, 60) as k from documents), f as (select k, min_by(text, doc_id) as original from d group by k having count(*) > 1),
p as (select doc_id as pair_id, original, text as corrected from d join f using (k) where text <> original)"""
DIFF = """, s as (select pair_id, 'o' as side, unnest({o}) as token from p union all select pair_id, 'c', unnest({c}) from p),
m as (select pair_id, token, count(*) filter (side = 'o') as original, count(*) filter (side = 'c') as corrected from s where token <> '' group by all)"""
WORD_DIFF = DIFF.format(o="regexp_split_to_array(original, '\\s+')", c="regexp_split_to_array(corrected, '\\s+')")


@query("select source, sum(len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{1,}'))) ::bigint as words, sum(len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]*')))::bigint as bench_words from documents group by source")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).groupBy("source").agg(F.sum(F.size(T.mining_words(t))).alias("words"), F.sum(F.size(T.bench_words(t))).alias("bench_words"))


_SENT = r"regexp_split_to_array(text, '[.!?]+[\x22\x27)\]]*\s+')"


@query(f"select doc_id, len(list_filter({_SENT}, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 3))::bigint as sentences from documents")
def sentence_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"), 3)).cast("bigint").alias("sentences"))


# DuckDB's patterns look neither back nor ahead: a boundary takes a character. Where texts have each character that is no word
# character twice, one is left for the next match.
_DOUBLED = r"regexp_replace(lower({}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
_PASSIVE = rf"len(regexp_extract_all({_DOUBLED.format('text')}, '(?:^|[^\p{{L}}\p{{N}}_])(?:is|are|was|were|be|been|being)\s+(?:[\p{{L}}\p{{N}}_]+ly\s+)?[\p{{L}}\p{{N}}_]+(?:ed|en)(?:$|[^\p{{L}}\p{{N}}_])'))"


@query(f"""with s as (select source, len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{{1,}}')) as w, len(list_filter({_SENT}, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 3)) as n,
{_PASSIVE} as p, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x = 'we')) as we from documents)
select source, sum(w)::bigint as words, sum(n)::bigint as sentences, sum(w) / greatest(sum(n), 1) as avg_sentence_words, sum(p) * 10000 / greatest(sum(w), 1) as passive_per_10k, sum(we) * 10000 / greatest(sum(w), 1) as we_per_10k from s group by source""")
def field_stats(spark, sf_dir):
    return mining.field_stats(docs(spark, sf_dir))


@query(f"select doc_id, {_PASSIVE}::bigint as passives from documents")
def passive_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.count(F.col("text"), X.PASSIVE).alias("passives"))


_TOKENS = "t as (select source, doc_id, i - 1 as pos, w[i] as word, lower(w[i]) as term from (select source, doc_id, w, unnest(generate_series(1, len(w))) as i from (select *, regexp_extract_all(text, '[A-Za-z][A-Za-z-]{1,}') as w from documents)))"
_STOPS = ", ".join(f"'{s}'" for s in STOP)


@query(f"""with {_TOKENS}, c as (select source, term, count(*) as cnt, min(row(doc_id, pos)) as f from t where len(term) >= 3 and word <> upper(word) and term not in ({_STOPS}) group by all)
select source, rank, term, cnt from (select *, row_number() over (partition by source order by cnt desc, f) as rank from c) where rank <= 30""")
def top_terms(spark, sf_dir):
    return mining.top_terms(docs(spark, sf_dir), STOP)


@query(f"""with {_TOKENS}, b as (select *, first_value(case when len(term) >= 3 and term not in ({_STOPS}) then term end ignore nulls) over (partition by doc_id order by pos rows between 4 preceding and 1 preceding) as before from t),
c as (select source, before || ' ' || term as phrase, count(*) as cnt, min(row(doc_id, pos)) as f from b where term in ({", ".join(f"'{a}'" for a in ANCHORS)}) and before is not null group by all)
select source, rank, phrase, cnt from (select *, row_number() over (partition by source order by cnt desc, f) as rank from c) where rank <= 20""")
def phrase_bank(spark, sf_dir):
    return mining.phrase_bank(docs(spark, sf_dir), ANCHORS, STOP)


def _variant_sql(v: str) -> str:
    doubled = "".join(c if c.isalnum() or c == "_" else c * 2 for c in v)
    return rf"len(regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}_]){doubled}(?:$|[^\p{{L}}\p{{N}}_])'))"


# SQL has NFC only. The supplied texts hold no compatibility characters; a test holds the operators against NFKC on texts that do.
_VARIANTS = f"with d as (select doc_id, source, {_DOUBLED.format('nfc_normalize(text)')} as t from documents), v as (" + " union all ".join(f"select doc_id, source, '{f[0]}' as family, {i} as ord, '{v}' as variant, {_variant_sql(v)} as cnt from d" for f in FAMILIES for i, v in enumerate(f)) + ")"


@query(f"{_VARIANTS} select source, family, variant, sum(cnt)::bigint as cnt from v where cnt > 0 group by all")
def notation_watch(spark, sf_dir):
    return mining.notation_watch(docs(spark, sf_dir), families=FAMILIES)


@query(f"{_VARIANTS} select doc_id, family, count(*) as variants, max_by(variant, row(cnt, -ord)) as majority from v where cnt > 0 group by all having count(*) >= 2")
def inconsistent_families(spark, sf_dir):
    return lint.notation_issues(docs(spark, sf_dir), families=FAMILIES)


def _role_sql() -> str:
    roles = " ".join(f"when low in ({', '.join(repr(w) for w in words)}) then '{name}'" for name, words in X.SECTION_ROLES.items())
    return f"case when (contains(low, 'result') or contains(low, 'finding')) and contains(low, 'discussion') then 'merged: results+discussion' {roles} end"


# All sections of the documents as `parts`: lines, headings with a role among them, and a group from each heading to the next.
_SECTIONS = rf"""lists as (select doc_id, source, coalesce(text, '') as text, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') as a from documents),
rows_ as (select doc_id, source, i, a[i] as line, regexp_extract(a[i], '{X.HEADING}', 1) as name from (select *, unnest(generate_series(1, case when a[-1] = '' then len(a) - 1 else len(a) end)) as i from lists)),
roles as (select *, {_role_sql()} as role from (select *, lower(trim(name)) as low from rows_)),
placed as (select *, count(role) over (partition by doc_id order by i) as g, count(role) over (partition by doc_id) as heads from roles),
found as (select doc_id, source, g, coalesce(max(trim(name)) filter (role is not null), 'frontmatter') as name, coalesce(max(role), 'frontmatter') as role, min(i)::int as start_line, trim(coalesce(string_agg(line, chr(10) order by i) filter (role is null), '')) as body from placed where heads > 0 group by doc_id, source, g),
parts as (select doc_id, source, (row_number() over (partition by doc_id order by g) - 1)::int as ord, name, role, start_line, body from found where g > 0 or body <> ''
union all select doc_id, source, 0, 'body', 'body', 1, text from lists where doc_id not in (select doc_id from found))"""


@query(f"with {_SECTIONS} select doc_id, ord, name, role, start_line, body from parts")
def section_split(spark, sf_dir):
    return sections.split_sections(docs(spark, sf_dir), "doc_id")


_SECTION_STATS = rf"""s as (select source, role, len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{{1,}}')) as w, len(list_filter({_SENT}, lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 3)) as n, {_PASSIVE} as p
from (select source, role, body as text from parts where role not in ('frontmatter', 'references')))"""


@query(f"with {_SECTIONS}, {_SECTION_STATS} select source, role, count(*) as sections, sum(w) / greatest(sum(n), 1) as avg_sentence_words, round(sum(round_even(p * 10000 / w, 1) * w) / sum(w), 6) as passive_per_10k from s where w > 0 group by all")
def section_metrics(spark, sf_dir):
    return mining.section_metrics(docs(spark, sf_dir)).withColumn("passive_per_10k", F.round("passive_per_10k", 6))


def _term_sql() -> str:
    single = ", ".join(f"('{f}', '{t}', {w})" for f, t, w in TERMS if " " not in t)
    many = " union all ".join(f"select doc_id, '{f}' as field, len(regexp_extract_all(regexp_replace(lower(text), '([^\\p{{L}}\\p{{N}}_ ])|( )', '\\1  ', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_]){t.replace(' ', '  ')}(?:$|[^\\p{{L}}\\p{{N}}_])')) * {w} as s from documents" for f, t, w in TERMS if " " in t)
    return f"""with k as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from documents), s as (select doc_id, field, weight as s from k join (values {single}) v(field, term, weight) using (term) union all {many}),
r as (select doc_id, field, sum(s)::bigint as score from s group by all having sum(s) > 0) select doc_id, rank, field, score from (select *, row_number() over (partition by doc_id order by score desc, field) as rank from r) where rank <= 3"""


@query(_term_sql())
def route_top_fields(spark, sf_dir):
    terms = spark.createDataFrame(list(TERMS), "field string, term string, weight int")
    return routing.route(docs(spark, sf_dir), terms, 3)


def _saved(d: DataFrame) -> DataFrame:
    m = manifest(d).where("doc_id % 7 <> 0")
    return m.withColumn("sha1", F.when(F.col("doc_id") % 11 == 0, F.lit("old")).otherwise(F.col("sha1")))


@query("""with m as (select source || '/' || doc_id || '.txt' as rel_path, doc_id, strlen(text) as size, sha1(text) as sha1 from documents), n as (select * from m where doc_id % 5 <> 0),
o as (select rel_path, size, case when doc_id % 11 = 0 then 'old' else sha1 end as sha1 from m where doc_id % 7 <> 0)
select rel_path, case when o.rel_path is null then 'arrived' when n.rel_path is null then 'removed' else 'changed' end as change from n full outer join o using (rel_path) where o.rel_path is null or n.rel_path is null or n.sha1 <> o.sha1 or n.size <> o.size""")
def corpus_manifest_diff(spark, sf_dir):
    """The manifest without each fifth document against one without each seventh and with old digests for each eleventh:
    the two versions are made here, so that all three kinds of change occur."""
    d = docs(spark, sf_dir)
    return history.manifest_diff(manifest(d).where("doc_id % 5 <> 0"), _saved(d), facts=("size", "sha1"))


_LICENCE = r"regexp_extract_all(regexp_replace(text, '\bCC (BY[A-Z-]*) (\d\.\d)', 'https://creativecommons.org/licenses/\1/\2', 'g'), '(?i)creativecommons\.org/licenses/(by[a-z-]*/\d\.\d)', 1)[1]"


@query(f"select 'CC ' || upper(replace({_LICENCE}, '/', ' ')) as licence, count(*) as papers from documents group by 1")
def licence_families(spark, sf_dir):
    """The supplied texts give licences by short names; here they become links, as the operator reads them."""
    linked = F.regexp_replace("text", r"\bCC (BY[A-Z-]*) (\d\.\d)", "https://creativecommons.org/licenses/$1/$2")
    return docs(spark, sf_dir).groupBy(T.licence(linked).alias("licence")).agg(F.count("*").alias("papers"))


@query("select source, count(*) as papers from documents where doc_id in (select doc_id from labels where quality = 1) group by source")
def licence_gate_active(spark, sf_dir):
    rec = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("active").alias("status"))
    return attribution.active(docs(spark, sf_dir), rec, "doc_id").groupBy("source").agg(F.count("*").alias("papers"))


@query("select source, count(*) as papers from documents d where not exists (select 1 from benchmark b where contains(d.text, b.text)) group by source")
def excluded_by_benchmark_passage(spark, sf_dir):
    d, b = docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    # A passage's first and last words may be parts of longer ones in a text; those between are whole there. A passage can so only
    # be where its second to sixth words are: they are looked up by equality. Passages too short for that are few; they
    # are compared with each text.
    spaced = lambda c: F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    words = F.col("w")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 5), " "))
    cut = b.where("text is not null").select(F.col("text").alias("passage"), spaced(F.col("text")).alias("w")).distinct()
    keyed = cut.where(F.size(words) >= 7).select(F.array_join(F.slice(words, 2, 5), " ").alias("h"), "passage")
    short = cut.where(F.size(words) < 7).select("passage")
    keys = d.select("doc_id", spaced(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(grams)).alias("h"))
    near = keys.join(keyed, "h").select("doc_id", "passage").distinct()
    hits = d.select("doc_id", "text").join(near, "doc_id").where(F.contains("text", "passage")).select("doc_id")
    hits = hits.unionByName(d.join(F.broadcast(short), F.contains("text", "passage"), "left_semi").select("doc_id")).distinct()
    return attribution.not_excluded(d, hits, "doc_id").groupBy("source").agg(F.count("*").alias("papers"))


@query(r"""select doc_id, kind, token, count(*) as cnt from (select doc_id, 'number' as kind, regexp_extract(r, '^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?', 0) as token, r from (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_.]+')) as r from documents)
where regexp_matches(r, '^\d')) where regexp_matches(r, '^\d+(?:\.\d+)?(?:[eE]\d+)?\.*$') group by all""")
def invariants_number(spark, sf_dir):
    return invariants.invariants(docs(spark, sf_dir), "doc_id", kinds=("number",))


@query()
def invariants_all(spark, sf_dir):
    return invariants.invariants(docs(spark, sf_dir), "doc_id")


@query(PAIRS + WORD_DIFF + " select pair_id, token, original, corrected, greatest(original - corrected, 0) as missing, greatest(corrected - original, 0) as invented from m")
def multiset_missing_invented(spark, sf_dir):
    return invariants.word_multisets(pairs(spark, sf_dir))


@query(PAIRS + WORD_DIFF + " select pair_id, 2 * sum(least(original, corrected)) / sum(original + corrected) as dice, bool_and(original = corrected) as strict from m group by pair_id")
def multiset_dice(spark, sf_dir):
    return invariants.dice(invariants.word_multisets(pairs(spark, sf_dir)), "pair_id")


@query(PAIRS + WORD_DIFF + " select pair_id, 1 - 2 * sum(least(original, corrected)) / sum(original + corrected) as bound from m group by pair_id")
def change_rate_lower_bound(spark, sf_dir):
    return invariants.change_rate_bound(pairs(spark, sf_dir))


@query()
def category_stats(spark, sf_dir):
    return invariants.category_stats(invariants.multiset_diff(pairs(spark, sf_dir)))


@query()
def change_rate(spark, sf_dir):
    return invariants.change_rates(pairs(spark, sf_dir))


@query()
def level_gate(spark, sf_dir):
    return invariants.verify_pairs(pairs(spark, sf_dir), level="low")


_REVERSE = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Za-z0-9]{1,9}) \(([a-z][A-Za-z -]{2,60})\)"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# A document's own text and its acronyms: runs of word characters with a percent sign that no letter or digit follows.
_OWN = rf"""{_SECTIONS}, own as (select doc_id, any_value(source) as source, trim(coalesce(string_agg(body, chr(10) || chr(10) order by ord) filter (role <> 'references'), '')) as text from parts group by doc_id),
runs as (select doc_id, source, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '{X.CITATION_BRACKET}', ' ', 'g'), '{X.CITATION_AUTHOR.replace("'", "''")}', ' ', 'g'), '%([A-Za-z0-9])', ' \1', 'g'), '[\p{{L}}\p{{N}}_]+%?')) as run from own),
known as (select distinct doc_id, unnest(list_concat(regexp_extract_all(text, '{X.DEFINED_FORWARD}', 2), regexp_extract_all(replace(text, ')', '))'), '{_REVERSE}', 1))) as acronym from own),
used as (select doc_id, source, regexp_extract(run, '^([A-Z][A-Za-z0-9]{{1,9}}%?)(?:$|[^A-Za-z0-9])', 1) as acronym, count(*) as cnt from runs group by all),
undefined as (select * from used anti join known using (doc_id, acronym) where acronym <> '' and not regexp_matches(acronym, '[a-z]') and acronym not in ({_in(X.ACRONYMS_KNOWN + X.ACRONYMS_SKIPPED)}))"""


@query(f"with {_OWN} select doc_id, acronym, cnt from undefined")
def undefined_acronyms(spark, sf_dir):
    return lint.undefined_acronyms(docs(spark, sf_dir))


# Definitions with their places, the first of each wording, and for each acronym the first and the first that differs from it.
_DEFS = rf"""raw as (select source, doc_id, text, regexp_extract_all(text, '{X.DEFINED_FORWARD}', 1) as fe, regexp_extract_all(text, '{X.DEFINED_FORWARD}', 2) as fa, replace(text, ')', '))') as r from (select source, doc_id, coalesce(text, '') as text from documents)),
both_ as (select source, doc_id, 0 as kind, i - 1 as pos, fa[i] as acronym, list_filter(string_split(fe[i], ' '), lambda w: w <> '') as words, null as reverse from (select *, unnest(generate_series(1, len(fa))) as i from raw) union all
select source, doc_id, 1, n + i - 1, ra[i], null, re[i] from (select *, unnest(generate_series(1, len(ra))) as i from (select source, doc_id, len(fa) as n, regexp_extract_all(r, '{_REVERSE}', 1) as ra, regexp_extract_all(r, '{_REVERSE}', 2) as re from raw))),
defs as (select source, doc_id, kind, pos, acronym, coalesce(reverse, array_to_string(words[list_position(list_transform(words, lambda w: lower(w[1])), lower(acronym[1])):], ' '), '') as expansion from both_),
firsts as (select source, acronym, lower(trim(expansion)) as low, min(row(doc_id, kind, pos, expansion)) as f from defs where len(expansion) >= 3 and not regexp_matches(lower(expansion), '{'|'.join(X.AFFILIATIONS)}') and acronym not in ({_in([*X.ACRONYM_STOPWORDS, *X.ELEMENTS])}) group by all),
led as (select *, first_value(low) over w as low1, first_value(f[4]) over w as e1 from firsts window w as (partition by source, acronym order by f)),
folded as (select source, acronym, any_value(e1) as expansion, min(f) filter (not contains(low, low1) and not contains(low1, low)) as other from led group by all)"""


@query(f"""with {_OWN}, {_DEFS}, seen as (select source, acronym, sum(cnt) as seen from undefined where acronym not in ({_in([*X.ACRONYM_STOPWORDS, *X.ELEMENTS])}) group by all)
select acronym, source as field, 'corpus' as provenance, case when expansion is null then 'unverified' when other is null then 'verified' else 'conflict' end as status, expansion,
case when expansion is null then [] when other is null then [expansion] else [expansion, other[4]] end as expansions_seen, (if(expansion is null, 0, 1) + coalesce(seen, 0))::bigint as sightings from folded full join seen using (source, acronym)""")
def abbrev_registry_fold(spark, sf_dir):
    return registry.fold_registry(docs(spark, sf_dir))


@query()
def manuscript_state(spark, sf_dir):
    return registry.learn_state(docs(spark, sf_dir))


@query()
def style_rates_before_after(spark, sf_dir):
    return lint.style_rates(pairs(spark, sf_dir), ["in order to", "plays a key role"])


@query()
def journal_coverage(spark, sf_dir):
    """A journal of one entry for each line that differs."""
    p = pairs(spark, sf_dir)
    line = lambda c: F.transform(F.split(c, "\n"), lambda x: x)
    sides = F.zip_with(line("original"), line("corrected"), lambda o, c: F.struct(F.coalesce(o, F.lit("")).alias("o"), F.coalesce(c, F.lit("")).alias("c")))
    changed = p.select("pair_id", F.posexplode(F.filter(sides, lambda x: x["o"] != x["c"])).alias("ord", "x"))
    entry = F.struct(F.lit("changed").alias("kind"), F.col("x.o").alias("original"), F.col("x.c").alias("corrected"), F.struct(F.lit("rules").alias("source"), F.lit("r1").alias("id")).alias("rule"), F.lit("line").alias("reason"))
    return journal.check_journal(p, changed.select("pair_id", "ord", entry.alias("entry")))


@query("""with e as (select user_id as pair_id, (event_id % 1000)::bigint as s, (event_id % 1000 + user_id % 40)::bigint as e from events),
b as (select *, max(e) over (partition by pair_id order by s, e rows between unbounded preceding and 1 preceding) as before from e),
i as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by pair_id order by s, e rows unbounded preceding) as i from b) select pair_id, min(s) as s, max(e) as e from i group by pair_id, i""")
def merge_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return journal.merge_spans(e.select(F.col("user_id").alias("pair_id"), (F.col("event_id") % 1000).alias("s"), (F.col("event_id") % 1000 + F.col("user_id") % 40).alias("e")))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def latest_record_per_key(spark, sf_dir):
    return history.latest(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by event_id) as r from events) where r = 1")
def history_dedupe(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    return history.keep_first(e, ["user_id", "event_type", "day"], "event_id").select("user_id", "event_type", "event_id")


_TERM_LISTS = f"{_TOKENS}, c as (select source, (doc_id // 20) % 2 as half, term, count(*) as cnt from t where len(term) >= 3 group by all), k as (select source, half, term from (select *, row_number() over (partition by source, half order by cnt desc, term) as r from c) where r <= 30), l as (select source, list(term) filter (half = 0) as a, list(term) filter (half = 1) as b from k group by source)"


def _term_lists(spark, sf_dir):
    t = mining.tokens(docs(spark, sf_dir)).where("length(term) >= 3").groupBy("source", F.expr("doc_id div 20 % 2").alias("half"), "term").agg(F.count("*").alias("cnt"))
    k = t.withColumn("r", F.row_number().over(Window.partitionBy("source", "half").orderBy(F.desc("cnt"), "term"))).where("r <= 30")
    one = lambda h: F.collect_list(F.when(F.col("half") == h, F.col("term")))
    return k.groupBy("source").agg(one(0).alias("a"), one(1).alias("b"))


def _overlaps(spark, sf_dir):
    return _term_lists(spark, sf_dir).select("source", history.term_overlap(F.col("b"), F.col("a")).alias("term_overlap"))


@query(f"with {_TERM_LISTS} select source, len(list_intersect(a, b)) / greatest(len(a), len(b), 1) as term_overlap from l")
def term_overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir)


_BANK = ORACLES["phrase_bank"].replace("where rank <= 20", "where rank <= 1000 and cnt >= 5")


@query(f"""with {_SECTIONS}, {_SECTION_STATS}, bank as ({_BANK}), terms as ({ORACLES["top_terms"]}), own as (select source, list(term order by rank) as top_terms from terms group by source), l as (with {_TERM_LISTS} select source, a as before from l),
n as (select source, count(*) as papers, sum(len(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{{1,}}')))::bigint as words from documents group by source having bool_or(regexp_matches(text, '\\S'))),
p as (select source, papers, words, (select count(*) from bank b where b.source = n.source) as collocations, (select count(distinct role) from s where s.source = n.source and w > 0) as sections, round(len(list_intersect(top_terms, before)) / greatest(len(top_terms), len(before), 1), 3) as term_overlap, top_terms from n left join own using (source) left join l using (source))
select source, papers, words, collocations, sections, term_overlap, round(term_overlap * 20.0::double + least(papers / 20::double, 1.0::double) * 25.0::double + least(collocations / 20::double, 1.0::double) * 25.0::double + least(sections / 5::double, 1.0::double) * 15.0::double + least(words / 100000::double, 1.0::double) * 15.0::double, 1) as score, top_terms from p""")
def coverage_score(spark, sf_dir):
    """Coverage records of the fields; the first half of the documents' terms stand for those of the run before."""
    before = _term_lists(spark, sf_dir).select("source", F.col("a").alias("top_terms"))
    return coverage.coverage(docs(spark, sf_dir), before, ANCHORS, STOP)


@query("select source, count(*) as papers, count(*) >= 500 as major from documents group by source")
def major_fields(spark, sf_dir):
    return coverage.majors(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("papers")), least=500)


@query("select event_type, max(ts)::date as as_of from events group by event_type")
def as_of_dates(spark, sf_dir):
    return coverage.as_of(_events(spark, sf_dir), "event_type", modified="ts")


@query("select distinct doc_id as id from documents where doc_id not in (select doc_id from labels)")
def unlabelled_works(spark, sf_dir):
    return attribution.new_works(docs(spark, sf_dir).select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query()
def section_alignment(spark, sf_dir):
    return sections.align_sections(pairs(spark, sf_dir))


@query()
def definition_contexts(spark, sf_dir):
    return registry.contexts(docs(spark, sf_dir))


_RANKED = "r as (select source, row_number() over (order by count(*) desc, source) as rank from documents group by source)"


@query(f"with {_RANKED}, h as (select ceil(max(rank) / 2)::bigint as half from r) select l.source as \"left\", r.source as \"right\" from r l cross join h left join r on r.rank = l.rank + half where l.rank <= half")
def half_split_ranking(spark, sf_dir):
    n = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source")).cast("bigint"))  # a row per field
    return history.half_split(ranked, "rank", "source")


def _records(spark, sf_dir):
    m = docs(spark, sf_dir).select(F.col("source").alias("Subject"), F.lit("t").alias("title"), F.lit("A B; C D").alias("authors"), F.lit("2026-01-01").alias("publication_date"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("DOI"), F.col("doc_id").alias("relative_pdf_path"))
    lic = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("relative_pdf_path")).agg(F.when(F.max("quality") == 1, "CC BY 4.0").otherwise("CC BY-NC 4.0").alias("licence"))
    return attribution.records(m, lic)


@query("select source as subject, count(*) as papers from documents group by source")
def papers_per_field(spark, sf_dir):
    return attribution.papers_per_subject(docs(spark, sf_dir), "source").withColumnRenamed("source", "subject")


@query("""select 'ART-' || lpad(row_number() over (order by source, doc_id)::varchar, greatest(4, 0), '0') as record_id, doc_id as path, coalesce(l.licence, 'unknown') as licence, case when l.licence = 'CC BY 4.0' then 'active' else 'excluded' end as status
from documents left join (select doc_id, case when max(quality) = 1 then 'CC BY 4.0' else 'CC BY-NC 4.0' end as licence from labels group by doc_id) l using (doc_id)""")
def record_ids(spark, sf_dir):
    return _records(spark, sf_dir).select("record_id", "path", "licence", "status")


@query("select role, turn, count(*) as n, grouping_id(role, turn)::bigint as gid from (select role, turn::varchar as turn from conversations) group by grouping sets ((role), (turn), ())")
def harvest_distribution(spark, sf_dir):
    return generate.harvest(table(spark, sf_dir, "conversations").select("role", F.col("turn").cast("string").alias("turn")), "role", "turn")


def _scored(spark, sf_dir):
    p = pairs(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), "source", "lang"), "pair_id")
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("articles").alias("class"), F.when(F.col("pair_id") % 2 == 0, "minor").otherwise("major").alias("severity"), F.array(F.slice(F.regexp_extract_all("corrected", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)), 1, 1)).alias("accept")))
    meta = F.struct(F.col("source").alias("field"), F.lit("articles").alias("error_class"), F.lit("minor").alias("severity"), (F.col("pair_id") % 3 == 0).alias("no_edit"), F.col("lang").alias("source_doc_id"))
    cases = p.select(F.col("pair_id").cast("string").alias("case_id"), F.col("original").alias("input"), F.col("corrected").alias("gold"), first.alias("edits"), meta.alias("meta"))
    # Candidates make the edits of the first half of the lines.
    half = lambda c, first: F.slice(F.split(c, "\n"), F.lit(1) if first else F.col("_n") + 1, F.col("_n") if first else F.size(F.split(c, "\n")))
    halved = cases.withColumn("_n", F.floor(F.size(F.split("gold", "\n")) / 2).cast("int"))
    return benchmark.scores(cases, halved.select("case_id", F.array_join(F.concat(half("gold", True), half("input", False)), "\n").alias("text")))


@query()
def benchmark_report(spark, sf_dir):
    return benchmark.report(_scored(spark, sf_dir))


@query()
def regression_cases(spark, sf_dir):
    return generate.failing(_scored(spark, sf_dir))


@query("select l_returnflag as grade, l_linestatus as field, avg(l_quantity) as mean, count(*) as n, grouping_id(l_linestatus, l_returnflag)::bigint as gid from lineitem group by grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def grade_field_grouping(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grade"), F.col("l_linestatus").alias("field"), "l_quantity")
    return benchmark.grouped(s, "l_quantity", [["grade"], ["field"], ["grade", "field"]])


def _arms(spark, sf_dir):
    s = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("a"), F.max("toxic").cast("double").alias("b"))
    arm = lambda c: s.select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 10).cast("string").alias("source_doc_id"), F.col(c).alias("score"))
    return benchmark.paired(arm("a"), arm("b"))


@query("with s as (select doc_id, max(quality)::double as a, max(toxic)::double as b from labels group by doc_id) select avg(a) as mean_on, avg(b) as mean_off, avg(a - b) as mean_difference, coalesce(stddev_samp(a - b), 0) as sd_difference, count(*) as n from s")
def paired_difference_summary(spark, sf_dir):
    return benchmark.summary(_arms(spark, sf_dir)).select(*[F.round(c, 9).alias(c) if c != "n" else c for c in ("mean_on", "mean_off", "mean_difference", "sd_difference", "n")])


ORACLES["paired_difference_summary"] = f"select round(mean_on, 9) as mean_on, round(mean_off, 9) as mean_off, round(mean_difference, 9) as mean_difference, round(sd_difference, 9) as sd_difference, n from ({ORACLES['paired_difference_summary']})"


@query("select event_type, value from (select *, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) as n from events where value is not null) where r = floor((n - 1) * 0.975)")
def nearest_rank_percentile(spark, sf_dir):
    return benchmark.nearest_rank(_events(spark, sf_dir).where("value is not null"), ["event_type"], "value", 0.975)


@query("select n, 2.802::double * 0.35::double / sqrt(n) as mde from (values (100::bigint), (200::bigint), (400::bigint), (800::bigint)) v(n)")
def mde_table(spark, sf_dir):
    return benchmark.mde_table(spark.range(4).select((F.lit(100) * F.pow(F.lit(2), F.col("id"))).cast("bigint").alias("n")), 0.35)


@query()
def cluster_bootstrap_ci(spark, sf_dir):
    return benchmark.bootstrap_interval(_arms(spark, sf_dir))


_PASSAGE = r"""coalesce(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: len(string_split(s, ' ')) >= 5)[1],
case when len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 5 then array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:80], ' ') end)"""


@query(f"select doc_id, source, row_number() over (partition by source order by doc_id) as seq, passage from (select doc_id, source, {_PASSAGE} as passage from documents where doc_id not in (select doc_id from labels)) where passage is not null")
def control_passages(spark, sf_dir):
    return generate.control_passages(docs(spark, sf_dir), table(spark, sf_dir, "labels"))


@query()
def synthetic_corruption(spark, sf_dir):
    return generate.corruptions(generate.control_passages(docs(spark, sf_dir)))


@query()
def placeholder_edits(spark, sf_dir):
    return generate.placeholder_edits(pairs(spark, sf_dir))


@query("""with n as (select *, row_number() over (order by role, conv_id, turn) - 1 as i from conversations) select conv_id, turn, role, ['a', 'b', 'c'][(i % 3) + 1] as field from n""")
def round_robin_fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("case"))
    return generate.round_robin(c, ["a", "b", "c"], "case", "role").select("conv_id", "turn", "role", "field")


@query("select sha256('[' || string_agg('\"' || doc_id::varchar || '\"', ',' order by doc_id::varchar) || ']') as fingerprint, count(*) as cases from documents")
def case_set_fingerprint(spark, sf_dir):
    return benchmark.fingerprint(docs(spark, sf_dir), "doc_id")


@query("select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, regexp_extract(html, '(?is)<svg\\b[^>]*>.*?</svg>', 0) as svg from pages")
def page_title_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return rules.first_svg(pages).select("page_id", "title", "svg")
