"""Construction of benchmark data: control passages, single corruptions, pilot assembly, harvest and regression capture."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import align
from ..functions import text as T
from .places import running

# What each corruption swaps.
NUMBER_SWAPS = {"is": "are", "are": "is", "was": "were", "were": "was", "has": "have", "have": "has"}
FIGURE_SWAPS = {"shows": "showed", "lists": "listed", "indicates": "indicated", "demonstrates": "demonstrated"}
CLASS_OF = {"P5": ("korean-translationese", "minor"), "P6": ("korean-translationese", "major"), "R3": ("section-tense", "major")}
_ARTICLE = re.compile(r"\b(?:the|a|an) (?=[a-z])", re.I)


def control_passages(docs: DataFrame, registered: DataFrame | None = None, n: int | None = None, key: str = "doc_id", field: str = "source") -> DataFrame:
    """key, field, seq, passage: one passage of each document that isn't registered yet, the first n of each field by key."""
    left = docs if registered is None else docs.join(registered.select(key), key, "left_anti")
    got = left.select(key, field, T.passage(F.col("text")).alias("passage")).where("passage is not null")
    if n is not None:  # a bounded number of each field: tasks keep their first n before the shuffle
        return got.withColumn("seq", F.row_number().over(Window.partitionBy(field).orderBy(key)).cast("bigint")).where(F.col("seq") <= n)
    return running(got, [field], key, "seq", keys_of=docs).select(key, field, "seq", "passage")


def _corrupt(text: str, rule: str) -> tuple[str, str, str] | None:
    """(corrupted text, what was there, what is there) with exactly one change, or None if the rule doesn't apply."""
    if re.search(r"\d|\[|\bet al\b", text):
        return None
    if rule == "P5":
        hit = _ARTICLE.search(text, 1)
        return (text[: hit.start()] + text[hit.end() :], hit.group().strip(), "") if hit else None
    for m in re.finditer(r"[A-Za-z]+", text):
        new = (NUMBER_SWAPS if rule == "P6" else FIGURE_SWAPS).get(m.group())
        if new:
            return text[: m.start()] + new + text[m.end() :], m.group(), new
    return None


def corruptions(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, rule, class, severity, input (corrupted), gold, i1, i2: cases whose alignment has one difference."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, p in zip(batch[key], batch["passage"], strict=True):
                for rule, (kind, severity) in CLASS_OF.items():
                    made = _corrupt(p, rule)
                    if made:
                        ops = [op for op in align.opcodes(align.tokens(made[0]), align.tokens(p)) if op[0] != "equal"]
                        if len(ops) == 1:
                            rows.append((k, rule, kind, severity, made[0], p, ops[0][1], ops[0][2]))
            yield pd.DataFrame(rows, columns=[key, "rule", "class", "severity", "input", "gold", "i1", "i2"])

    return passages.select(key, "passage").mapInPandas(run, f"{key} bigint, rule string, class string, severity string, input string, gold string, i1 int, i2 int")


def quotas(cases: DataFrame, per_group: int, *groups: str) -> DataFrame:
    """The first per_group cases of each group by case_id."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("case_id"))
    return cases.withColumn("_p", place).where(F.col("_p") <= per_group).drop("_p")


def round_robin(cases: DataFrame, fields: list[str], key: str = "case_id", group: str = "class") -> DataFrame:
    """cases with field: fields in turn over (group, key), going on across groups. Places are per group plus offsets."""
    per = cases.groupBy(group).agg(F.count("*").alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = running(cases, [group], key, "_p").withColumn("_p", F.col("_p") - 1).join(before, group)
    names = F.array(*[F.lit(f) for f in fields])
    return numbered.withColumn("field", F.element_at(names, ((F.col("_p") + F.col("_before")) % len(fields) + 1).cast("int"))).drop("_p", "_before")


def assemble(controls: DataFrame, synthetic: DataFrame, natural: DataFrame, target: int, per_class: int) -> DataFrame:
    """Controls (a quarter of the target, 30 at least), per_class synthetic cases of each rule, natural cases up to target."""
    cols = ["case_id", "kind"]
    c = controls.orderBy("case_id").limit(max(30, target // 4)).withColumn("kind", F.lit("control")).select(cols)
    s = quotas(synthetic, per_class, "rule").withColumn("kind", F.lit("synthetic")).select(cols)
    base = c.unionByName(s)
    left = max(0, target - base.count())  # one number
    return base.unionByName(natural.orderBy("case_id").limit(left).withColumn("kind", F.lit("natural")).select(cols))


def harvest(edits: DataFrame, *dims: str) -> DataFrame:
    """Counts by each dimension and in total, in one scan."""
    cols = [F.col(d) for d in dims]
    return edits.groupingSets([[c] for c in cols] + [[]], *dims).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("gid"))


def failing(scored: DataFrame) -> DataFrame:
    """Cases to capture: an edit was missed or a control was changed."""
    return scored.where((F.col("score") < 1) | (F.coalesce("no_edit", F.lit(False)) & (F.col("changed") > 0)))


def placeholder_edits(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, edits: the differing opcodes as edits without a class, of severity major; pairs without differences go."""
    ops = pairs.select(key, align.alignment("original", "corrected").alias("ops"))
    made = F.transform(F.filter("ops", lambda o: o["tag"] != "equal"), lambda o: F.struct(o["i1"].alias("start"), o["i2"].alias("end"), F.lit(None).cast("string").alias("class"), F.lit("major").alias("severity")))
    return ops.select(key, made.alias("edits")).where("size(edits) > 0")


def next_sequence(existing: DataFrame, arrivals: DataFrame, day: str = "date", key: str = "slug") -> DataFrame:
    """arrivals with seq: numbers per day that go on after the highest there is."""
    top = existing.groupBy(day).agg(F.max("seq").alias("_top"))
    place = F.row_number().over(Window.partitionBy(day).orderBy(key))
    return arrivals.withColumn("_p", place).join(top, day, "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + F.col("_p")).drop("_p", "_top")


def candidates(entries: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """name, input, gold, edits, source_doc_id, meta, review of logged edits (path, original, corrected, meta as JSON): pending cases with
    placeholder edits. Absolute paths in meta are hidden; a source id that is one gives way to the entry's path. Names are the path's parts; a
    name that is taken, or that several paths give, goes on with the first free of -2, -3 and so on."""
    base = F.replace("path", F.lit("/"), F.lit("-"))
    given = F.get_json_object("meta", "$.source_doc_id")
    sid = F.when((F.coalesce(given, F.lit("")) != "") & ~F.startswith(given, F.lit("/")), given).otherwise(F.col("path"))
    rows = entries.where(F.coalesce(F.get_json_object("meta", "$.field"), F.lit("")) != "").select(base.alias("_base"), F.col("path").alias("pair_id"), "original", "corrected", sid.alias("source_doc_id"), T.redacted(F.col("meta")).alias("meta"))
    edits = placeholder_edits(rows)
    named = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy("pair_id")))
    if taken is not None:
        number = lambda c: F.when(F.col("name") == F.col("_base"), F.lit(1)).otherwise(F.regexp_extract("name", r"-(\d+)$", 1).try_cast("int"))
        used = taken.select("name", F.explode(F.array_distinct(F.array("name", F.regexp_replace("name", r"-\d+$", "")))).alias("_base"))
        used = used.groupBy("_base").agg(F.collect_set(number("name")).alias("_used"))
        free = F.filter(F.sequence(F.lit(1), F.col("_n") + F.size("_used")), lambda i: ~F.array_contains("_used", i))
        named = named.join(used, "_base", "left").withColumn("_n", F.when(F.col("_used").isNull(), F.col("_n")).otherwise(F.element_at(free, F.col("_n"))))
    name = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))
    full = named.withColumn("name", name).join(edits, "pair_id", "left")
    none = F.array().cast(edits.schema["edits"].dataType)
    return full.select("name", F.col("original").alias("input"), F.col("corrected").alias("gold"), F.coalesce("edits", none).alias("edits"), "source_doc_id", "meta", F.lit("pending").alias("review"))
